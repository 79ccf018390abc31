"""The registered queries: SQL where there is some, and the contract's columns."""

from __future__ import annotations

import zlib

import duckdb
import pyarrow.parquet as pq
import pytest

from lodestone.llm import queries
from tests.test_catalogue import SF, TABLES, rows

COLUMNS = {
    "op1_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op2_token_records": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op3_bpe_round_trip": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op4_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op5_line_dedup": ["doc_id", "removed", "text_sha256"],
    "op6_context_mixing": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op7_warc_index_merge": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op8_ngram_jaccard_join": ["doc_id", "class_id"],
    "op9_benchmark_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op10_phrase_fingerprint": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op11_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op12_filter_interactions": ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
    "op13_periodic_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
}
FOLDS = {"op1_language_id": (3, 1), "op4_toxicity": (5, 0), "op6_context_mixing": (10, 0)}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    found = queries.QUERIES[name](spark, SF).toPandas()
    assert list(found.columns)[: len(COLUMNS[name])] == COLUMNS[name]
    table = "pages" if name.startswith("op7") else "documents"
    assert len(found) == (600 * found.part.nunique() if name.startswith("op12") else pq.read_metadata(f"{SF}/{table}.parquet").num_rows)
    if name in FOLDS:
        n, k = FOLDS[name]
        assert all(h == (zlib.crc32(str(i).encode()) % n == k) for i, h in zip(found.doc_id, found.held_out, strict=True))
    if name in queries.SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
        assert rows(found) == rows(con.execute(queries.SQL[name]).df())


def test_languages_of_held_out_documents(spark):
    found = queries.QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "lang"]).to_pandas()
    held = found[found.held_out].merge(docs, on="doc_id")
    assert (held.lang_pred == held.lang).mean() > 0.98
